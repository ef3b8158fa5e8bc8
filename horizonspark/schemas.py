"""Fixed schemas of the input and output tables, as DDL."""

DAILY = "date date, demand double, floortables double"
STORMS = "date date, typhoon_name string, highest_signal int"
HOURLY = "date date, hour int, demand double"
RESERVATIONS_COUNTS = "update_date string, inhouse_date string, rooms_otb string"
RESERVATIONS_PATRONS = "update_date string, inhouse_date string, patron_id string"
PREDICTIONS = "date date, p10 double, p50 double, p90 double"
RUN_METADATA = (
    "run_date string, model string, horizon_days int, historical_data_range array<string>, forecast_range array<string>, p50_min double, p50_max double, "
    "p50_mean double, p50_sum double, generated_at string, use_reservations boolean, use_weather boolean, initial_forecast boolean, initial_forecast_range array<string>, _corrupt_record string"
)
WORKDAYS = "date date, is_workday boolean"
