"""Layer catalog and rulesets."""
