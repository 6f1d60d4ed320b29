"""Search settings, their repair, and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, replace

from ringweave.operators.targets import CASE, ORBIT

EXPAND, FIRST_GATE, PRODUCT = "expand", "first_gate", "product"


@dataclass(frozen=True)
class SearchConfig:
    """``target``: largest gate count. ``stored``: levels made by expansion (0: all but one).

    ``beyond`` says how levels past ``stored`` come about: ``expand`` keeps
    expanding and is complete; ``product`` multiplies the stored level by the coset
    generators (its first step by gate 0 alone); ``first_gate`` stops after that
    first step. The latter two reach only part of each level.
    """

    target: int = 8
    stored: int = 0
    pattern_path: str | None = None
    out_path: str | None = None
    root: str = ""
    match: str = CASE
    beyond: str = EXPAND
    legacy_suffix: bool = False
    stop_when_done: bool = False
    record_beyond: bool = True

    def repaired(self) -> "SearchConfig":
        """Depths brought into range: 1 <= target, half of target <= stored < target."""
        target = max(1, self.target)
        stored = self.stored
        if stored <= 0 or stored > target - 1:
            stored = target - 1
        return replace(self, target=target, stored=max(stored, -(-target // 2)))

    @property
    def free_depth(self) -> int:
        """Levels made by multiplication instead of expansion."""
        return self.target - self.stored

    @property
    def generating_sets(self) -> int:
        """How many coset levels the multiplication needs."""
        return max(0, min(self.target - 1 - self.stored, self.stored))


def parse_args(argv: list[str] | None = None) -> SearchConfig:
    p = argparse.ArgumentParser(prog="ringweave", description="level-by-level exact search")
    p.add_argument("-t", "--tcount", type=int, default=8, help="largest gate count")
    p.add_argument("-s", "--stored-depth", type=int, default=0, help="levels made by expansion")
    p.add_argument("-f", "--pattern-file", help="72-character pattern lines")
    p.add_argument("-o", "--out", help="folder for witness circuits, one subfolder per level")
    p.add_argument("-r", "--root", default="", help="circuit at the root of the search tree")
    p.add_argument("-c", "--cases", action="store_true", help="do not record past the stored depth")
    p.add_argument("--match", choices=[CASE, ORBIT], default=CASE)
    p.add_argument("--beyond", choices=[EXPAND, FIRST_GATE, PRODUCT], default=EXPAND)
    p.add_argument("--legacy-suffix", action="store_true", help="also drop coset words that end in gate 10")
    p.add_argument("--stop-when-done", action="store_true", help="stop once no target is open")
    # Spark decides parallelism and logging; accepted so that old command lines still run.
    p.add_argument("-n", "--threads", help="ignored: set spark.master or executor counts instead")
    p.add_argument("-v", "--verbose", action="store_true", help="print one line per level")
    a = p.parse_args(argv)
    return SearchConfig(
        target=a.tcount,
        stored=a.stored_depth,
        pattern_path=a.pattern_file,
        out_path=a.out,
        root=a.root,
        match=a.match,
        beyond=a.beyond,
        legacy_suffix=a.legacy_suffix,
        stop_when_done=a.stop_when_done,
        record_beyond=not a.cases,
    ).repaired()
