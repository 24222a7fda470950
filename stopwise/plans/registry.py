"""Queries of the capture-analysis engine by name, and their DuckDB SQL."""

from __future__ import annotations

from stopwise.plans import oracles, queries

FLAGSHIP = "copy_assessment"
NAMES = (
    "acutance_patch", "gaussian_blur_patch", "median_luminance", "contrast_texture_gate", "zone_geometry", "zone_projection",
    "green_extract", "luma_extract", "rgb_split", "bayer_interpolate", "green_correlation", "top_centre_falloff", "level_normalise", "row_col_profiles", "profile_variance_gate",
    "lag_scores", "ca_shift", "trace_points", "quadratic_fit", "distortion_frame", "target_runs", "keystone", "target_qa_frame",
    "analyse_frames", "analyse_runs", "falloff_stops", "correction_gate", "group_frames", "decentring_pairs", "ca_group", "distortion_group", "target_quality_group",
    "vignetting_group", "stable_repeats", "fc_samples", "field_curvature", "vignetting_partitions", "vignetting_series_flags",
    "vignetting_optical_delta", "vignetting_symmetry", "vignetting_uncontrolled", "copy_candidates", "copy_series_summary", "copy_assessment", "reshoot_actions",
    "run_report_json", "batch_records", "contact_sheets", "contact_layout", "thumbnail_sample", "inspect_files", "folder_inputs", "extension_dispatch", "metadata_inspect",
)
QUERIES = {n: getattr(queries, n) for n in NAMES}
ORACLES: dict[str, str] = oracles.SQL
