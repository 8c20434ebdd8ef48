"""Every constant of the telemetry operators, as presets that can be scaled in time."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """Durations in seconds, lengths in metres, speeds in metres per second unless said otherwise."""

    horizon_lo: int = 600
    horizon_hi: int = 900
    active: int = 180
    match_radius: float = 90.0
    match_window: int = 300
    plan_lead: int = 30
    trip_gap: int = 900
    windows: tuple[int, ...] = (300, 600, 900, 1800)
    window_names: tuple[str, ...] = ("5m", "10m", "15m", "30m")
    matched_short: int = 1800
    matched_long: int = 3600
    idle_speed: float = 5.0
    jump_min: float = 800.0
    jump_speed: float = 50.0
    center_max: float = 40_000.0
    corridor: float = 5_000.0
    route_snap: float = 400.0
    prior_cut: int = 1200
    alert: float = 120.0
    clip: tuple[float, float] = (-420.0, 700.0)
    whatif_clip: tuple[float, float] = (-600.0, 700.0)
    bunching_share: float = 0.35
    counting: str = "online"  # how matched stops are counted: by the size of the delay, or offline by the age of the plan

    def scaled(self, k: int) -> Profile:
        """All durations times k, speeds divided by k; lengths and results as they are."""
        times = ("horizon_lo", "horizon_hi", "active", "match_window", "plan_lead", "trip_gap", "matched_short", "matched_long")
        return replace(self, jump_speed=self.jump_speed / k, windows=tuple(w * k for w in self.windows), **{t: getattr(self, t) * k for t in times})


ONLINE = Profile()
OFFLINE = Profile(match_radius=70.0, match_window=900, plan_lead=0, counting="offline")
#: The driver's tables have a fix every few hours where vehicles send one every few seconds.
FIXTURE = ONLINE.scaled(120)
