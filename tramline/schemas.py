"""Schemas of the tables at rest."""

from __future__ import annotations

TRAFFIC = "tr_id long, unit_id long, event_time timestamp_ntz, lat double, lon double, alt double, speed double, heading double, location_valid boolean"
SCHEDULE = "tt_action_item_id long, tr_id long, time_begin timestamp_ntz, time_fact_begin string, geom string, building_address string"
POINTS = "sample_id string, tr_id long, T timestamp_ntz, target_stop_id long, target_time_begin timestamp_ntz, cur_dev_s double, target_delay_s string"
ELEMENTS = "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>"
NAV = "unit_id long, ts long, lat double, lon double, location_valid boolean, speed double, heading double, altitude double, nsat int"
