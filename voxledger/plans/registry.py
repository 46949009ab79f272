"""Applications: how their files are parsed, which levels they have, and how entries are classified."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.operators import headers
from voxledger.operators.rules import UNCLASSIFIED


@dataclass(frozen=True)
class Application:
    """One application: `parse` takes lines (or blocks, if it has them) and returns entries."""

    app_id: str
    levels: tuple[str, ...]
    parse: Callable[[DataFrame], DataFrame]
    has_blocks: bool = False
    category: Callable[[], Column] = lambda: F.lit(UNCLASSIFIED)


class Registry:
    """Applications by id, in the order of their ids."""

    def __init__(self, *apps: Application):
        self._apps: dict[str, Application] = {}
        for a in apps:
            self.add(a)

    def add(self, app: Application) -> None:
        if not app.app_id.strip() or not app.levels or not callable(app.parse):
            raise ValueError("an application needs an id, levels and a parser")
        if app.app_id in self._apps:
            raise ValueError(f"{app.app_id} is registered already")
        self._apps[app.app_id] = app

    def get(self, app_id: str) -> Application | None:
        return self._apps.get(app_id)

    def ids(self) -> list[str]:
        return sorted(self._apps)


def default_registry() -> Registry:
    return Registry(
        Application("ORK", headers.ORK_LEVELS, headers.parse_blocks, True),
        Application("VOCI", headers.VOCI_LEVELS, headers.parse_voci),
        Application("VPL", headers.VPL_LEVELS, headers.parse_blocks, True),
    )
