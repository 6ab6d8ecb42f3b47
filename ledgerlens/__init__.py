"""ledgerlens: deterministic analytics over public-money data, declared as Spark DataFrame plans."""
