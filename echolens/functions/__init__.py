"""Column expressions shared by the operators (no session, no action)."""
