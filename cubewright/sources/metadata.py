"""Scan commands: what a scan's title says of its shape and motors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# For each command the token of each axis's number of points, the token of each
# axis's motor (none: no motors), whether numbers are intervals, and which axes are integrated.
COMMANDS = {
    "ascan": ((3,), (0,), True, (False,)),
    "fscan": ((3,), (0,), False, (True,)),
    "a2scan": ((6,), (0,), True, (False,)),
    "d2scan": ((6, 6), (0, 3), False, (False, False)),
    "fscan2d": ((3, 7), (0, 4), False, (False, True)),
    "loopscan": ((0,), None, False, (None,)),
    "amesh": ((3, 7), (0, 4), True, (False, False)),
}


@dataclass(frozen=True)
class ScanCommand:
    """A parsed title. shape counts points; motor_names is None for scans without motors."""

    title: str
    command: str
    shape: tuple[int, ...]
    motor_names: tuple[str, ...] | None
    integrated: tuple[bool | None, ...]
    scan_id: str = ""
    invariant: dict = field(default_factory=dict)

    @property
    def points(self) -> int:
        return math.prod(self.shape)

    @property
    def kind(self) -> str:
        """darks, rocking or mosa, by the number of moving motors."""
        n = len(self.motor_names or ())
        return ("darks", "rocking", "mosa")[n] if n < 3 else "mosa"


def parse_command(title: str, scan_id: str = "") -> ScanCommand:
    """The scan a title describes; ValueError for an unknown command or missing tokens."""
    command, *args = title.split()
    if command not in COMMANDS:
        raise ValueError(f"unknown scan command: {command}")
    shape_at, names_at, intervals, integrated = COMMANDS[command]
    try:
        shape = tuple(int(args[i]) + intervals for i in shape_at)
        names = None if names_at is None else tuple(args[i] for i in names_at)
    except (IndexError, ValueError) as e:
        raise ValueError(f"can't read the scan command {title!r}") from e
    return ScanCommand(title, command, shape, names, integrated, scan_id)


def choose_motor(candidates: dict[str, list], points: int) -> str:
    """The first path whose array has a value for each point; ValueError with a hint otherwise."""
    for path, values in candidates.items():
        if len(values) == points:
            return path
    raise ValueError(f"Could not find a motor with {points} values among {sorted(candidates)}; an aborted scan loads with allow_partial=True")


def fit_length(values: list, n_frames: int) -> list[float]:
    """A motor's values for n_frames: longer arrays are cut, a single value is repeated."""
    if len(values) >= n_frames:
        return [float(v) for v in values[:n_frames]]
    if len(values) == 1:
        return [float(values[0])] * n_frames
    raise ValueError(f"{len(values)} motor values for {n_frames} frames")


def matching_scans(scan_ids: list[str], suffix: str) -> list[str] | str:
    """Ids that end with suffix, sorted as numbers where all are; a single one by itself."""
    found = [s for s in scan_ids if s.endswith(suffix)]
    try:
        found.sort(key=float)
    except ValueError:
        found.sort()
    return found[0] if len(found) == 1 else found
