"""What a run may take: memory of a task, the tile that fits in it, disk for what lies between and for the output."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass
from pathlib import Path

from rasterloom.plans.settings import Settings, size_in_bytes
from rasterloom.sources.tiff import Header, Refused

MIB = 1 << 20
# Fixed values.
#: Sides that ``auto`` chooses from, the largest budget it takes, and the share of the free memory that is taken at most.
SIDES, MOST, SHARE = (2048, 1536, 1024, 512), 4 << 30, 0.6
#: How much larger than the pixels a packed output may get; others stay below 1.1.
GROWTH = {"lzw": 1.6}
#: Bytes of all planes of a window for each of its places, without and with a pyramid; and what a task needs besides.
PLANES, BESIDES = (160, 240), 160 * MIB


@dataclass(frozen=True)
class Allowance:
    """What a run may use: bytes of memory of a task, the tile's side, bytes of disk between and for the output."""

    budget: int
    tile: int
    scratch: int
    output: int


@dataclass(frozen=True)
class Need:
    """Bytes that something takes, and what to say if they are not there."""

    what: str
    size: int

    def over(self, most: int, of: str) -> Refused | None:
        return Refused(f"{self.what} needs {self.size >> 20} MiB and {of} is {most >> 20} MiB") if self.size > most else None


def free_memory(root: Path = Path("/sys/fs/cgroup")) -> int:
    """Of this machine, or of the container if that is less; clean pages of files count as free."""
    free = os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
    known = Path("/proc/meminfo")
    if known.exists():
        lines = dict(line.split(":", 1) for line in known.read_text().splitlines() if ":" in line)
        free = int(lines.get("MemAvailable", f"{free // 1024} kB").split()[0]) * 1024
    try:
        limit = (root / "memory.max").read_text().strip()
        if limit != "max":
            pages = dict(line.split() for line in (root / "memory.stat").read_text().splitlines())
            clean = sum(int(pages.get(k, 0)) for k in ("inactive_file", "active_file")) - sum(int(pages.get(k, 0)) for k in ("file_dirty", "file_writeback"))
            free = min(free, max(0, int(limit) - int((root / "memory.current").read_text()) + max(0, clean)))
    except (OSError, ValueError):
        pass
    return free


def budget(text: str, free: int) -> int:
    """What is asked for, but never more than a share of what is free."""
    return min(int(free * SHARE), size_in_bytes(text) or MOST)


def tile_need(settings: Settings, side: int) -> Need:
    """All planes of a tile's window."""
    whole = side + 2 * (settings.halo + settings.grid)
    return Need(f"a tile of {side}", whole * whole * PLANES[settings.levels > 0] + BESIDES)


def memory_needs(heads: list[Header]) -> list[Need]:
    """What the files themselves ask of a task, whatever the tiles: the output's rows, and each packed segment with its copies."""
    rows = Need("a row of the output", heads[0].shown[1] * 36 + 128 * MIB)
    return [rows, *[Need(f"{head.path}: a segment", 2 * (max(head.counts) + head.seg_h * head.seg_w * 3 * head.depth // 8) + 64 * MIB) for head in heads if not head.plain]]


def disk_needs(heads: list[Header], settings: Settings) -> tuple[int, int]:
    """Bytes between (plain forms of packed frames, three planes, what alignment keeps) and of the output."""
    h, w = heads[0].shown
    plain = sum(head.h * head.w * 3 * head.depth // 8 for head in heads if not head.plain)
    looks = 0 if settings.alignment == "none" else len(heads) * min(settings.analysis_bound, max(h, w)) ** 2 * 8
    return plain + looks + h * w * 12, int(h * w * 6 * GROWTH.get(settings.compression, 1.1)) + 4 * MIB


def allowed(heads: list[Header], settings: Settings, folder: str | Path, place: str | Path, free: int | None = None) -> Allowance:
    """Refuses a run that memory or disk does not suffice for, before any pixel is read."""
    most = budget(settings.memory_budget, free_memory() if free is None else free)
    tiles = {side: tile_need(settings, side) for side in (SIDES if settings.tile_size == "auto" else [settings.tile_size])}
    fits = [side for side, need in tiles.items() if need.size <= most]
    for need in [*memory_needs(heads), *([] if fits else [tiles[min(tiles)]])]:
        if refusal := need.over(most, "the memory budget"):
            raise refusal
    scratch, output = disk_needs(heads, settings)
    disks: dict[int, Need] = {}
    for at, size in ((folder, scratch), (place, output)):  # one disk may have to hold both
        disk = os.stat(at).st_dev
        disks[disk] = Need(f"{at}: the run", size + (disks[disk].size if disk in disks else 0))
    for at, need in disks.items():
        if refusal := need.over(shutil.disk_usage(folder if at == os.stat(folder).st_dev else place).free, "the free disk"):
            raise refusal
    return Allowance(most, max(fits), scratch, output)
