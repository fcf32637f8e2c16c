"""Limits, thresholds and fixed marker strings, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    drop_threshold: float = 0.25
    remember_threshold: float = 0.75
    recall_cutoff: float = 0.5
    protected_tail_tokens: int = 12000
    pressure_ratio: float = 0.65
    token_budget: int = 32000
    token_limit: int = 32000
    inject_budget: int = 2000
    shortlist_limit: int = 20
    link_seeds: int = 8
    max_query_tokens: int = 64
    page_bytes: int = 4096
    request_budget: int = 2000
    summary_allowance: int = 4000
    reserve_tokens: int = 65536
    keep_recent_tokens: int = 32000
    item_overhead: int = 32
    batch_slack: int = 1024
    batch_floor: int = 4096
    k1: float = 1.2
    b: float = 0.75
    judge_has_cap: bool = True
    estimator: str = "utf8-div-4"
    #: Fixed value: what the judge is asked of each passage; its length counts towards the cap.
    recall_instructions: str = "High probability means this passage materially helps with the current request. Low probability means it does not."
    window_id: str = "context:fresh-window"
    window_line: str = "[context: fresh window; earlier turns stay in the session log. Stored tool output can be expanded.]"
    summary_marker: str = "[context: fresh window"
    pointer_format: str = "[context: tool output stored; expand pointer=%s page=0]"


DEFAULTS = Settings()
CONVERSATION = "conversation"
