"""Entity x day panel build (the main preparation pipeline).

raw meter text -> typed readings (ISO-prefix day, safe numeric casts, NaN
and negative totals dropped) -> inner join static entity attributes ->
left join region x day covariates on (region, day) -> calendar and ratio
features -> complete cases on the core variables -> fixed column set.

Joins: the entity dimension and the region x day covariates are left to
Catalyst/AQE (broadcast when measured small, shuffle-hash/sort-merge on
the key otherwise); everything else is narrow and fuses into one stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S
from panelkit.operators.joins import null_safe_join

# --- fixed values: raw column names and output column set of the daily panel ---
METER_COLUMNS = ["Household_ID", "Timestamp", "kWh_received_Total", "kWh_received_HeatPump",
                 "kWh_received_Other", "kWh_returned_Total"]
META_COLUMNS = ["Household_ID", "Weather_ID", "Group"]
HOUSEHOLD_COLUMNS = ["Household_ID", "Survey_Building_Type", "Survey_HeatPump_Installation_Type",
                     "Survey_Building_LivingArea", "Survey_Building_Residents",
                     "Survey_HeatDistribution_System_FloorHeating", "Survey_HeatDistribution_System_Radiator",
                     "Survey_Installation_HasDryer", "Survey_Installation_HasFreezer",
                     "Survey_Installation_HasElectricVehicle"]
WEATHER_COLUMNS = ["Weather_ID", "Timestamp", "Temperature_max_daily", "Temperature_min_daily",
                   "Temperature_avg_daily", "HeatingDegree_SIA_daily", "CoolingDegree_US_daily",
                   "Humidity_avg_daily", "Precipitation_total_daily", "Sunshine_duration_daily"]
CORE_VARS = ["kWh_total", "living_area", "n_residents", "building_type", "heatpump_type",
             "weather_region", "has_floor_heating", "has_radiator", "temp_avg"]
PANEL_COLUMNS = ["Household_ID", "date", "year", "month", "weekday", "is_weekend", "kWh_total",
                 "kWh_heatpump", "kWh_other", "kWh_returned", "kWh_per_m2", "temp_avg", "temp_min",
                 "temp_max", "temp_range", "heating_degree_days", "cooling_degree_days", "humidity_avg",
                 "precipitation", "sunshine_hours", "weather_region", "group", "building_type",
                 "heatpump_type", "living_area", "n_residents", "has_floor_heating", "has_radiator",
                 "has_dryer", "has_freezer", "has_electric_vehicle"]
ANNUAL_MEASURES = {"annual_kWh_total": "kWh_received_Total", "annual_kWh_heatpump": "kWh_received_HeatPump",
                   "annual_kWh_other": "kWh_received_Other", "annual_kWh_returned": "kWh_returned_Total"}
ANNUAL_CORE_VARS = ["annual_kWh_total", "living_area", "n_residents", "building_type", "heatpump_type",
                    "weather_region", "has_floor_heating", "has_radiator"]
ANNUAL_COLUMNS = ["Household_ID", "annual_kWh_total", "living_area", "temp_avg", "temp_range",
                  "heating_degree_days", "cooling_degree_days", "humidity_avg", "precipitation_total",
                  "annual_kWh_returned", "kWh_per_m2", "weather_region", "building_type", "heatpump_type",
                  "group", "n_residents", "has_floor_heating", "has_radiator", "has_dryer", "has_freezer",
                  "has_electric_vehicle", "high_consumption"]
FLAGS_FILLED = ["has_electric_vehicle", "has_dryer", "has_freezer"]
# --- end fixed values ---


def typed_readings(raw: DataFrame) -> DataFrame:
    """All-text meter rows -> typed daily readings; bad rows dropped."""
    out = raw.select(
        F.col("Household_ID").cast("string").alias("Household_ID"),
        S.iso_prefix_date("Timestamp").alias("date"),
        S.safe_double("kWh_received_Total").alias("kWh_total"),
        S.safe_double("kWh_received_HeatPump").alias("kWh_heatpump"),
        S.safe_double("kWh_received_Other").alias("kWh_other"),
        S.safe_double("kWh_returned_Total").alias("kWh_returned"))
    return out.where(F.col("date").isNotNull() & F.col("kWh_total").isNotNull() & (F.col("kWh_total") >= 0))


def entity_attributes(meta: DataFrame, households: DataFrame) -> DataFrame:
    """Static attributes: meta left-join survey answers, typed; NA flags -> 0
    for the appliance flags (heating flags stay NULL, as in the source)."""
    m = meta.select(F.col("Household_ID").cast("string").alias("Household_ID"), "Weather_ID", "Group")
    h = households.withColumn("Household_ID", F.col("Household_ID").cast("string"))
    j = null_safe_join(m, h, ["Household_ID"], "left")
    out = j.select(
        "Household_ID",
        F.col("Weather_ID").cast("string").alias("weather_region"),
        F.col("Group").cast("string").alias("group"),
        F.col("Survey_Building_Type").cast("string").alias("building_type"),
        F.col("Survey_HeatPump_Installation_Type").cast("string").alias("heatpump_type"),
        S.safe_double("Survey_Building_LivingArea").alias("living_area"),
        S.safe_int("Survey_Building_Residents").alias("n_residents"),
        S.safe_bool_int("Survey_HeatDistribution_System_FloorHeating").alias("has_floor_heating"),
        S.safe_bool_int("Survey_HeatDistribution_System_Radiator").alias("has_radiator"),
        S.safe_bool_int("Survey_Installation_HasDryer").alias("has_dryer"),
        S.safe_bool_int("Survey_Installation_HasFreezer").alias("has_freezer"),
        S.safe_bool_int("Survey_Installation_HasElectricVehicle").alias("has_electric_vehicle"))
    return out.fillna(0, subset=FLAGS_FILLED)


def typed_covariates(raw: DataFrame) -> DataFrame:
    """Region x day weather rows -> typed covariates with temperature range."""
    d = {c: S.safe_double(c) for c in WEATHER_COLUMNS[2:]}
    return raw.select(
        F.col("Weather_ID").cast("string").alias("weather_region"),
        S.iso_prefix_date("Timestamp").alias("date"),
        d["Temperature_max_daily"].alias("temp_max"), d["Temperature_min_daily"].alias("temp_min"),
        d["Temperature_avg_daily"].alias("temp_avg"),
        (d["Temperature_max_daily"] - d["Temperature_min_daily"]).alias("temp_range"),
        d["HeatingDegree_SIA_daily"].alias("heating_degree_days"),
        d["CoolingDegree_US_daily"].alias("cooling_degree_days"),
        d["Humidity_avg_daily"].alias("humidity_avg"),
        d["Precipitation_total_daily"].alias("precipitation"),
        d["Sunshine_duration_daily"].alias("sunshine_hours"))


def assemble_panel(readings: DataFrame, attributes: DataFrame, covariates: DataFrame,
                   core_vars: Sequence[str] = CORE_VARS, columns: Sequence[str] | None = PANEL_COLUMNS,
                   entity: str = "Household_ID", region: str = "weather_region",
                   area: str = "living_area", measure: str = "kWh_total",
                   ratio_name: str = "kWh_per_m2") -> DataFrame:
    """Join, derive calendar/ratio features, keep complete cases, project."""
    j = null_safe_join(null_safe_join(readings, attributes, [entity]), covariates, [region, "date"], "left")
    cal = S.calendar_columns("date")
    j = j.withColumns({"year": cal["year"], "month": cal["month"], "weekday": cal["weekday"],
                       ratio_name: S.guarded_ratio(measure, area)})
    j = j.withColumn("is_weekend", (F.col("weekday") >= 6).cast("int"))
    j = j.dropna(subset=list(core_vars))
    return j.select(*columns) if columns else j


def build_daily_panel(meter_raw: DataFrame, meta: DataFrame, households: DataFrame,
                      weather_raw: DataFrame) -> DataFrame:
    return assemble_panel(typed_readings(meter_raw), entity_attributes(meta, households),
                          typed_covariates(weather_raw))


# ---------------------------------------------------------------- annual dataset

def annual_consumption(monthly: DataFrame, entity: str, year: str, measures: Sequence[str],
                       total: str, min_months: int = 10) -> DataFrame:
    """Entity-month rows -> one row per entity with the median over complete
    years of each annual measure.

    Per entity-year: months present and NULL-as-0 sums; a year is complete
    with >= ``min_months`` months and a positive ``total``; sums are scaled
    to 12 months; an entity has few years, so their median is Spark's grouped
    percentile, in the same aggregate as their count.
    """
    measures = list(measures)
    yearly = monthly.groupBy(entity, year).agg(
        F.count(F.lit(1)).alias("months_available"),
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in measures])
    full = (yearly.where((F.col("months_available") >= min_months) & (F.col(total) > 0))
            .withColumns({m: F.col(m) * 12 / F.col("months_available") for m in measures}))
    return full.groupBy(entity).agg(*[F.percentile(F.col(m), F.lit(0.5)).alias(m) for m in measures],
                                    F.count(F.lit(1)).alias("n_complete_years"))


def annual_covariates(daily: DataFrame, region: str, date: str, means: dict, sums: dict) -> DataFrame:
    """Region x day covariates -> per region: the average over years of each
    year's mean (``means``: name -> column) or NULL-as-0 total (``sums``)."""
    per_year = daily.groupBy(region, F.year(date).alias("_year")).agg(
        *[F.avg(c).alias(n) for n, c in means.items()],
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()])
    names = list(means) + list(sums)
    return per_year.groupBy(region).agg(*[F.avg(n).alias(n) for n in names])


def assemble_annual(attributes: DataFrame, consumption: DataFrame, covariates: DataFrame,
                    entity: str, region: str, total: str, area: str, core_vars: Sequence[str],
                    flag: str = "high_consumption", ratio_name: str = "kWh_per_m2") -> DataFrame:
    """attributes x consumption (inner) x covariates (left); the above-median
    flag uses the median of the joined rows *before* incomplete rows are
    dropped; then complete cases on ``core_vars``.  Joins match missing keys
    to missing keys.  The covariates are one row per region and cannot change
    the median, so it is taken from the entities alone, written once."""
    from panelkit.operators.quantile import quantiles_wide
    from panelkit.sources.io import checkpoint_table
    known = checkpoint_table(null_safe_join(attributes, consumption, [entity]), "annual_entities")
    med = quantiles_wide(known.select(total), total, [0.5], [], ["_median"])
    j = null_safe_join(known, covariates, [region], "left").withColumn(ratio_name, S.guarded_ratio(total, area))
    j = j.crossJoin(F.broadcast(med)).withColumn(flag, (F.col(total) > F.col("_median")).cast("int"))
    return j.drop("_median").dropna(subset=list(core_vars))


def build_annual_dataset(meter_raw: DataFrame, meta: DataFrame, households: DataFrame, weather_raw: DataFrame,
                         min_months: int = 10) -> DataFrame:
    """Raw monthly meter rows, entity tables and daily weather -> one row per
    entity with its annual consumption, attributes and average annual weather
    (``ANNUAL_COLUMNS``).

    A row per month file line counts as a month, unreadable numbers add
    nothing, a year needs ``min_months`` months and a positive total and is
    scaled to 12; appliance flags default to 0; the above-median flag is set
    before incomplete entities are dropped.
    """
    monthly = meter_raw.select(
        F.col("Household_ID").cast("string").alias("Household_ID"), F.year(S.iso_prefix_date("Timestamp")).alias("year"),
        *[S.safe_double(raw).alias(name) for name, raw in ANNUAL_MEASURES.items()])
    consumption = annual_consumption(monthly, "Household_ID", "year", list(ANNUAL_MEASURES), "annual_kWh_total", min_months)
    weather = annual_covariates(
        typed_covariates(weather_raw), "weather_region", "date",
        means={"temp_avg": F.col("temp_avg"), "temp_range": F.col("temp_range"), "humidity_avg": F.col("humidity_avg")},
        sums={"heating_degree_days": F.col("heating_degree_days"), "cooling_degree_days": F.col("cooling_degree_days"),
              "precipitation_total": F.col("precipitation")})
    out = assemble_annual(entity_attributes(meta, households), consumption, weather, "Household_ID", "weather_region",
                          "annual_kWh_total", "living_area", ANNUAL_CORE_VARS)
    return out.select(*ANNUAL_COLUMNS)
