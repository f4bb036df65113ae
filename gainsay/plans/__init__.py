"""Rules, the rule engine and reports."""
