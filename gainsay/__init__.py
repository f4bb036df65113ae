"""Cross-source evidence consistency checks as Spark DataFrame plans."""

from gainsay.plans.engine import DEFAULT_RULES, Rule, run, run_isolated
from gainsay.sources.case import CaseTables

__all__ = ["CaseTables", "DEFAULT_RULES", "Rule", "run", "run_isolated"]
