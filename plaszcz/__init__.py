"""plaszcz: deterministic detection and pseudonymisation of Polish identifiers on Spark."""
