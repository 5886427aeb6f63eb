"""All registered queries; importing this module imports the modules that hold them."""

from gridweave.plans import grid, scenarios  # noqa: F401
from gridweave.plans.registry import ORACLES, QUERIES  # noqa: F401
