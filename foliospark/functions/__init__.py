"""Column expressions shared by the operators and the plans (no UDFs)."""
