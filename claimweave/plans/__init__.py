"""Registered queries; the other modules add their own to the registry's."""

from claimweave.plans import registry, screening, case_plans, claim_plans, store_plans, view_plans  # noqa: F401
