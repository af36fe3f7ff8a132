"""Limits of the filters: three presets, overrides from the environment, and the boost for verbose commands.

A preset is a plain dict that is folded into the plan as literals; `preset_table` gives all of them as rows.
"""

from __future__ import annotations

import os

#: Limits of each preset (low, balanced, high risk of losing detail).
PRESETS: dict[str, tuple[float, float, float]] = {
    "generic_head": (30, 20, 10), "generic_tail": (45, 30, 15), "test_head": (15, 10, 8), "test_tail": (60, 40, 20),
    "build_head": (20, 15, 10), "build_tail": (35, 25, 15), "lint_head": (20, 15, 10), "lint_tail": (40, 30, 20),
    "typecheck_head": (20, 15, 10), "typecheck_tail": (40, 30, 20), "git_diff_file_head": (12, 8, 5), "git_diff_tail": (14, 10, 5),
    "git_log_head": (35, 25, 15), "git_log_tail": (20, 15, 8), "git_status_head": (80, 50, 25), "git_status_tail": (45, 30, 15),
    "git_status_group_max_per_line": (15, 10, 5), "log_head": (25, 15, 10), "log_tail": (45, 30, 20), "log_max_consecutive_dupes": (5, 3, 1),
    "fs_max_entries": (80, 50, 30), "fs_head_lines": (30, 20, 10), "fs_tail_lines": (45, 30, 15),
    "search_max_matches_per_file": (6, 5, 3), "search_max_files": (16, 15, 8), "search_head_lines": (30, 20, 10), "search_tail_lines": (45, 30, 15),
    "json_max_keys_per_object": (15, 10, 5), "json_max_array_items": (8, 5, 3), "json_max_depth": (4, 3, 2), "json_max_value_length": (160, 80, 50),
    "json_csv_min_rows": (3, 3, 3), "json_csv_max_rows": (30, 20, 10), "json_csv_max_key_length": (60, 40, 20), "json_kv_min_keys": (3, 3, 3), "json_kv_max_keys": (30, 20, 15),
    "json_dotkey_max_keys": (40, 30, 20), "json_dotkey_max_depth": (4, 3, 2), "json_csv_factor_threshold": (0.8, 0.8, 0.8), "json_csv_factor_max_columns": (3, 3, 3),
    "generic_stack_collapse_min_frames": (5, 5, 3), "generic_stack_collapse_keep_app_frames": (3, 2, 1),
    "oversized_max_chars": (500_000, 500_000, 500_000), "read_blank_line_max": (1, 1, 1), "read_comment_threshold": (10, 10, 10),
    "read_generated_min_line_len": (500, 500, 500), "read_generated_min_run": (5, 5, 5), "read_literal_threshold": (8, 8, 8),
}
LEVELS = ("low", "balanced", "high")
#: Switches, all on unless the environment says otherwise.
SWITCHES = ("redact", "strip_thinking", "normalize_paths", "binary_detection", "oversized_guard", "normalize_noise", "table_whitespace", "stack_collapse", "status_group", "heading_reformat", "build_summary", "lsl_abbreviate", "json_csv", "json_csv_factor", "json_kv", "json_dotkey", "read_import_collapse", "read_css_rule_collapse")
_NOT_BOOSTED = {"log_max_consecutive_dupes", "json_max_depth", "json_max_value_length", "git_status_group_max_per_line", "json_csv_min_rows", "json_csv_max_key_length", "json_kv_min_keys", "json_dotkey_max_depth", "json_csv_factor_threshold", "json_csv_factor_max_columns", "oversized_max_chars"}


def _upper(name: str) -> float:
    """The largest value that an override or a boost may reach."""
    if name == "oversized_max_chars":
        return 10_000_000
    if name == "json_csv_factor_threshold":
        return 1.0
    if name.endswith("depth"):
        return 10
    if name.endswith(("value_length", "key_length")):
        return 10_000
    return 1_000 if name.startswith(("json", "fs_max", "search_max")) else 500


def risk_level(name: str | None) -> str:
    name = (name or "").strip().lower()
    return name if name in LEVELS else "balanced"


def limits(level: str | None = None, env: dict[str, str] | None = None) -> dict:
    """A preset with overrides `SIEVELINE_<NAME>`: numbers that are invalid or negative are ignored, those
    above the largest value are cut to it; switches are on only for 1."""
    env = dict(os.environ) if env is None else env
    at = LEVELS.index(risk_level(level or env.get("SIEVELINE_RISK_LEVEL")))
    out: dict = {}
    for name, values in PRESETS.items():
        kind = float if name == "json_csv_factor_threshold" else int
        out[name] = kind(values[at])
        try:
            given = kind(env[f"SIEVELINE_{name.upper()}"])
        except (KeyError, ValueError):
            continue
        if given >= 0:
            out[name] = min(given, kind(_upper(name)))
    for name in SWITCHES:
        given = env.get(f"SIEVELINE_{name.upper()}_ENABLED", "").strip()
        out[name] = given == "1" if given.lstrip("-").isdigit() else True
    return out


def boosted(cfg: dict) -> dict:
    """Twice the lines and entries, for commands that ask for detail."""
    keep = lambda n: n in _NOT_BOOSTED or n in SWITCHES or n.startswith(("read_", "generic_stack"))
    return {n: v if keep(n) else min(2 * v, int(_upper(n))) for n, v in cfg.items()}


def enabled(env: dict[str, str] | None = None) -> bool:
    env = dict(os.environ) if env is None else env
    return env.get("SIEVELINE_FILTERS", "").strip().lower() not in ("off", "false", "0")


def workspace_root(env: dict[str, str] | None = None, start: str | None = None) -> str:
    """The folder of SIEVELINE_WORKSPACE_ROOT if there is one, else the next folder upwards, of twenty, that
    holds `.git`, else the start (the working folder). Read on the driver, once."""
    given = (dict(os.environ) if env is None else env).get("SIEVELINE_WORKSPACE_ROOT", "")
    if given and os.path.isdir(given):
        return given
    here = start = os.path.abspath(start or os.getcwd())
    for _ in range(20):
        if os.path.isdir(os.path.join(here, ".git")):
            return here
        here = os.path.dirname(here)
    return start


def project_roots(workspace: str) -> list[str]:
    """Folders two levels below the workspace's `projects`, or the workspace itself if there are none."""
    inner = os.path.join(workspace, "projects")
    folders = lambda at: [e.path for e in os.scandir(at) if e.is_dir()] if os.path.isdir(at) else []
    found = sorted(p for group in folders(inner) for p in folders(group))
    return [p.replace("\\", "/") for p in found or [workspace]]
