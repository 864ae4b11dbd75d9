"""Column functions shared by the operators (all JVM-side expressions)."""
