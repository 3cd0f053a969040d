"""All registered queries: each applies one operator to the driver's tables."""

from __future__ import annotations

from tessera.plans import alignment, arrays, checkpoints, containers, history, objects, scenarios, storage  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
