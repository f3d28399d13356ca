"""Schemas of the tables a run exchanges."""

from __future__ import annotations

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"

SITES = (
    "id_numeric int, site_id string, site_name string, start_date date, end_date date, "
    f"start_year int, end_year int, area_ha double, geometry {GEOMETRY}"
)
TREATMENT_KEY = "cell bigint, id_numeric int, area_ha double, site_id string"
FAILED_SITES = (
    "id_numeric int, site_id string, site_name string, error string, timestamp string, "
    "array_index int, failure_marker_file string"
)
BY_SITE_YEAR = (
    "site_id string, year int, treatment_defor_ha double, control_defor_ha double, "
    "forest_loss_avoided_ha double, treatment_emissions_mgco2e double, "
    "control_emissions_mgco2e double, emissions_avoided_mgco2e double, n_matched_pixels bigint, "
    "sampled_fraction double, site_name string, is_pre_intervention boolean"
)
BY_SITE_TOTAL = (
    "site_id string, forest_loss_avoided_ha double, emissions_avoided_mgco2e double, "
    "n_matched_pixels bigint, sampled_fraction double, first_year int, last_year int, "
    "n_years bigint, site_name string, area_ha double"
)
PAYLOAD_ENTITY = (
    "struct<entity_id:string,entity_name:string,year:int,period_start:int,period_end:int,"
    "values:map<string,double>,"
    "metadata:struct<n_matched_pixels:bigint,sampled_fraction:double,n_years:bigint,"
    "is_pre_intervention:boolean>>"
)
PAYLOAD = (
    "name string, analysis_type string, summary struct<task_id:string,n_sites:bigint,"
    "n_failed_sites:bigint,total_emissions_avoided_mgco2e:double,"
    "total_forest_loss_avoided_ha:double,total_area_ha:double,year_range_min:int,"
    f"year_range_max:int>, records array<{PAYLOAD_ENTITY}>, time_series array<{PAYLOAD_ENTITY}>"
)
