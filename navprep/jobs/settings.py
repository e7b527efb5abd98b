"""Resolved settings of a map job: small driver-side values, not data. Keys are those of the job's JSON."""

from __future__ import annotations

# Defaults of the job's settings.
DEFAULTS = {
    "voxel_size": 0.05, "map_name": "tsdf1", "max_depth_range": 10.0, "depth_tsdf_frame_stride": 1, "scan_transform_mode": "sensor_to_world", "is_flat_ground": True, "trajectory_clear_radius": 0.0,
    "map_sigma_smooth": 2.5, "obstacle_reassign_threshold": 0.3, "free_space_threshold": 0.7, "depth_raycast_ray_pixel_stride": 8, "depth_raycast_hit_pixel_stride": 3,
    "depth_raycast_min_depth": 0.35, "depth_raycast_depth_scale": 1000.0, "depth_raycast_endpoint_clearance": 0.08, "depth_raycast_min_hit_votes": 2, "depth_raycast_min_free_votes": 2,
    "depth_raycast_hit_ratio_threshold": 0.35, "depth_raycast_ray_thickness": 1, "depth_raycast_ignore_bottom_rows": 0, "depth_raycast_occupancy_inflation_radius": 0.0,
    "depth_raycast_obstacle_min_component_cells": 1, "depth_raycast_unknown_cost": 1.0, "depth_raycast_collision_cost_transition": 0.05, "depth_raycast_collision_cost_power": 1.0,
    "depth_raycast_free_carve_min_votes": 0, "depth_raycast_free_carve_max_hit_ratio": 0.5, "depth_raycast_surface_thinning_radius": 0.0, "clear_dist": 1.0,
}


def resolve(given: dict) -> dict:
    """given over the defaults, with fallbacks to other keys filled in; only these values reach a job."""
    s = DEFAULTS | given
    first = lambda *keys, other: next((s[k] for k in keys if k in s), other)
    s["cloud_source"] = first("cloud_source", "reconstruction_source", "map_source", other="depth").lower()
    width = s.get("robot_width")
    s["robot_size"] = float(first("robot_size", other=0.3 if width is None else width / 2))
    s["depth_tsdf_truncation"] = first("depth_tsdf_truncation", other=4 * s["voxel_size"])
    s["max_scan_range"] = first("max_scan_range", other=s["max_depth_range"])
    s["terrain_ground_height"] = first("terrain_ground_height", "ground_height", other=0.25)
    s["depth_raycast_frame_stride"] = first("depth_raycast_frame_stride", "depth_tsdf_frame_stride", other=1)
    s["depth_raycast_bounds_pixel_stride"] = first("depth_raycast_bounds_pixel_stride", other=max(s["depth_raycast_ray_pixel_stride"], s["depth_raycast_hit_pixel_stride"]))
    s["cloud_voxel"] = s["voxel_size"] * (1.0 if s["cloud_source"].startswith("depth_raycast") else 0.9)
    return s
