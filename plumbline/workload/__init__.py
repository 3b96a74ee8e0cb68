"""All registered queries; importing a module registers its queries."""

from plumbline.workload import abtests, contracts, drift, models, profiles, stress, tables
from plumbline.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "abtests", "contracts", "drift", "models", "profiles", "stress", "tables"]
