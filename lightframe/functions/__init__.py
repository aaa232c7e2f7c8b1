"""Column expressions: pure functions of columns, without joins or shuffles."""
