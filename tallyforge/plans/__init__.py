"""Ready-made analyses, one module per subject; importing this package registers all queries."""

from tallyforge.plans import (attendance, credit, digits, intake, investments, loans, pricing, requests, retail, selection,
                              tickets, trips, warehouse)
from tallyforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "attendance", "credit", "digits", "intake", "investments", "loans", "pricing", "requests",
           "retail", "selection", "tickets", "trips", "warehouse"]
