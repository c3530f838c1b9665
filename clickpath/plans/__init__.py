"""Named analyses. Importing this package registers every analysis module."""

from clickpath.plans import (  # noqa: F401
    attribution, crosssell, derived, fixed, landing, nonconverters, product, quality, repeat, revenue, traffic,
)
from clickpath.plans.registry import REGISTRY  # noqa: F401
